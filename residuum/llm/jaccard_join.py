"""Self-join of texts on the Jaccard likeness of word shingles, by PartEnum signatures.

Two sets as alike as asked differ in few elements for their sizes. Sizes are
cut into bands. For a band, the domain of shingles is partitioned (by a hash) on
two levels: into more than half as many parts as two such sets can differ in
elements, and each of them into three. So some part has one difference at most,
and the two sets agree in two of its three smaller parts. Each pair of smaller
parts gives a signature; sets that share none aren't alike. Each set takes part
in its own band, and as the larger of a pair also in that of its smallest partner.

Sets with the same signature are then compared, exactly, but never all with all
at once. Equal sets are one class, known by a 64-bit key of the set. In each
signature's group all classes meet the one of the smallest key, the hub. Links
with hubs join classes into components. Only groups in which several components
are left need more: there, classes outside the hub's component meet the others,
in blocks of bounded size, and what the counts of elements by bin already tell
apart is dropped at once. The pairs that remain are compared by their sets, so
that each link between components is found.

A null text, or one without words, has an empty set and links with nothing; with
fewer words than a shingle has, the whole sequence is one shingle. Rows with the
same doc_id are texts of their own. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from residuum.llm import text_bytes as tb
from residuum.llm.components import components
from residuum.plans.tables import discard, materialize, release, ship, table

WIDTH = 4
PERCENT = 85
#: Sizes of a band grow by this factor at most.
BAND = 1.5
#: First-level parts that there are beyond the least number, as a factor: so many more signatures are shared.
SLACK = 1.1
#: Signatures of fewer elements say little; they are left out where others suffice.
FEW = 2
#: Signatures that a worker holds before it deals them to buckets, and those of a bucket, about.
FLUSH = 1 << 20
LEAST_BUCKETS = 32
#: Classes of a group that are compared in one task; larger groups are cut into blocks.
BLOCK = 1024
#: Up to so many rows a list of signatures or of texts is sent to all tasks; longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Sets that are compared with one at once, about.
TOGETHER = 64


def bands(largest: int, factor: float = BAND) -> list[int]:
    """First sizes of the bands 1.., the last above ``largest``."""
    first = [1]
    while first[-1] <= largest:
        first.append(max(first[-1] + 1, int(np.ceil(first[-1] * factor))))
    return first


_FIRST = np.array(bands(1 << 40))
#: Pairs of the three second-level parts, and the third bits that name them.
_SUBSETS = ((0, 1), (0, 2), (1, 2))


def schemes(n: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(band, first-level parts, shared) of each band that a set of ``n`` elements takes part in.

    Alike sets share ``shared`` signatures of the band at least. With k differences
    dealt to m parts of three, those do most harm that come to parts without one
    (three equal pairs become one), then second ones (none is left).
    """
    least_partner = -(-percent * n // 100)
    found = []
    for band in range(*(int(np.searchsorted(_FIRST, s, side="right")) - 1 + more for s, more in ((least_partner, 0), (n, 1)))):
        top = int(_FIRST[band + 1]) - 1
        differ = (100 - percent) * (top + 100 * top // percent) // (100 + percent)
        parts = max(differ // 2 + 1, round(SLACK * differ / 2))
        found.append((band, parts, 3 * parts - 2 * differ if differ <= parts else 2 * parts - differ))
    return found


def signatures(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set of 64-bit elements: three for each first-level part of each of its bands.

    Signatures of few elements, or none, are left out where fewer of them are
    there than alike sets share: then alike sets share another one.
    """
    found = []
    for band, parts, shared in schemes(len(elements), percent):
        x = tb.mix64(elements ^ np.uint64(band * 7919 + 1))
        part = ((x >> np.uint64(32)) % np.uint64(3 * parts)).astype(np.int64)
        count = np.bincount(part, minlength=3 * parts).reshape(parts, 3)
        content = np.zeros(3 * parts, np.uint64)
        np.add.at(content, part, tb.mix64(x + np.uint64(5)))
        content = content.reshape(parts, 3)
        held = np.concatenate([count[:, a] + count[:, b] for a, b in _SUBSETS])
        name = tb.mix64(np.arange(3 * parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
        out = tb.mix64(np.concatenate([content[:, a] + content[:, b] for a, b in _SUBSETS]) + name)
        for few in range(FEW, 0, -1):
            if np.count_nonzero(held < few) < shared:
                out = out[held >= few]
                break
        found.append(out)
    return np.concatenate(found)


def set_key(elements: np.ndarray) -> int:
    """A 64-bit key of a set, as a signed number."""
    total = tb.mix64(elements * np.uint64(3) + np.uint64(11)).sum(dtype=np.uint64) + np.uint64(len(elements))
    return int(tb.mix64(np.array([total]))[0].astype(np.int64))


def bin_counts(elements: np.ndarray) -> bytes:
    """How many elements fall in each bin, up to three, in two bits; there are a power of two of bins, more than elements.

    Two sets differ in as many elements as their counts at least. Half as many
    bins are the sums of the two halves, up to three again.
    """
    bins = 1 << max(4, len(elements).bit_length())
    count = np.bincount((tb.mix64(elements) & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    quarters = np.minimum(count, 3).astype(np.uint8).reshape(4, -1)
    return (quarters[0] | quarters[1] << 2 | quarters[2] << 4 | quarters[3] << 6).tobytes()


def folded(counts: bytes, size: int) -> np.ndarray:
    """The counts, as many as ``size`` packed bytes hold; a byte has one bin of each quarter."""
    x = np.frombuffer(counts, np.uint8)
    bins = np.concatenate([x & 3, x >> 2 & 3, x >> 4 & 3, x >> 6])
    return np.minimum(bins.reshape(-1, 4 * size).sum(0, dtype=np.int16), 3)


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for _, data, offsets in tb.chunks(texts):
        words, at = tb.word_hashes(data, offsets)
        hashes, ends = tb.shingle_hashes(words, at, width)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield np.unique(hashes[a:b])


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).astype(np.int64)))


def describe(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, key, counts of each text; the last two null for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, keys, counts = [], [], []
                for s in _sets(batch.column(1), width):
                    n.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    counts.append(bin_counts(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.binary())],
                    names=["doc_id", "n_shingles", "key", "counts"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, key long, counts binary")


_BLOCK = "bucket long, keys binary, each binary, signatures binary"


def _block(bucket: int, signature: np.ndarray, key: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Rows of (signature, key) in one row: runs of a key have it once, with the run's length."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return bucket, key[first].tobytes(), np.diff(np.append(first, len(key))).astype(np.uint32).tobytes(), signature.tobytes()


def _unblock(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The signatures and keys of blocks."""
    def whole(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)

    return whole("signatures", np.uint64), np.repeat(whole("keys", np.int64), whole("each", np.uint32))


def _sorted(signature: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by signature and key, where each signature's run starts, and the runs' lengths."""
    order = np.lexsort((key, signature))
    signature, key = signature[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (signature[1:] != signature[:-1]) | (key[1:] != key[:-1])
    signature, key = signature[new], key[new]
    first = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]])) if len(key) else np.zeros(0, np.int64)
    return signature, key, first, np.diff(np.append(first, len(key)))


def blocks(docs: DataFrame, buckets: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Signatures of all texts, packed by bucket.

    Of sets that share a signature within a run of texts, the smallest key alone
    goes on to the signature's bucket, so frequent signatures don't fill it. Such
    sets are known to share one and form blocks of their own, above all buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0

        def flush(found: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
            nonlocal turn
            turn += 1
            signature, key, first, each = _sorted(np.concatenate(found), np.repeat(np.array(keys, np.int64), [len(f) for f in found]))
            together = np.repeat(each > 1, each)
            rows = [_block(buckets + (int(key[0]) + turn) % buckets, signature[together], key[together])] if together.any() else []
            signature, key = signature[first], key[first]
            bucket = (signature % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((key, bucket))
            signature, key, bucket = signature[order], key[order], bucket[order]
            ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
            for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
                rows.append(_block(int(bucket[a]), signature[a:b], key[a:b]))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                names=["bucket", "keys", "each", "signatures"],
            )

        found, keys, held = [], [], 0
        for batch in batches:
            for s in _sets(batch.column(0), width):
                if len(s):
                    found.append(signatures(s, percent))
                    keys.append(set_key(s))
                    held += len(found[-1])
                if held >= FLUSH:
                    yield flush(found, keys)
                    found, keys, held = [], [], 0
        if held:
            yield flush(found, keys)

    return docs.select("text").mapInArrow(run, _BLOCK)


def _shared(buckets: int):
    """(signature, key) of a bucket's signatures that several keys have, or of sets known to share them."""

    def run(group: pa.Table) -> pa.Table:
        signature, key = _unblock(group)
        if group.num_rows and group.column("bucket")[0].as_py() < buckets:
            signature, key, _, each = _sorted(signature, key)
            several = np.repeat(each > 1, each)
            signature, key = signature[several], key[several]
        return pa.table({"signature": signature.view(np.int64), "key": key})

    return run


def _small(rows: DataFrame) -> DataFrame:
    """A materialised frame, marked for broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _may_link(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in so many elements at least can be alike enough."""
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * differ <= (100 - percent) * (na + nb))


def _differ(a: bytes, b: bytes) -> int:
    """In how many elements two sets differ at least, by their counts."""
    size = min(len(a), len(b))
    return int(np.abs(folded(a, size) - folded(b, size)).sum())


def _can_link(percent: int):
    @F.arrow_udf("boolean")
    def check(na: pa.Array, ca: pa.Array, nb: pa.Array, cb: pa.Array) -> pa.Array:
        differ = np.array([_differ(a, b) for a, b in zip(ca.to_pylist(), cb.to_pylist(), strict=True)], dtype=np.int64)
        return pa.array(_may_link(na.to_numpy(zero_copy_only=False), nb.to_numpy(zero_copy_only=False), differ, percent))

    return check


def _alike(percent: int):
    """Of a group of sets those that are alike enough with the one of role 0."""

    def run(group: pa.Table) -> pa.Table:
        role, key = group.column("role").to_numpy(), group.column("key").to_numpy()
        sets = group.column("elements").combine_chunks()
        values, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
        hubs = np.flatnonzero(role == 0)
        good = []
        if len(hubs):
            hub = values[ends[hubs[0]] : ends[hubs[0] + 1]]
            for i in np.flatnonzero(role == 1):
                own = values[ends[i] : ends[i + 1]]
                same = int(np.isin(own, hub, assume_unique=True).sum())
                if 100 * same >= percent * (len(own) + len(hub) - same):
                    good.append(key[i])
        good = np.unique(np.array(good, dtype=np.int64))
        return pa.table({"a": pa.array(np.full(len(good), key[hubs[0]] if len(hubs) else 0, dtype=np.int64)), "b": pa.array(good)})

    return run


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of class keys those whose sets are alike enough.

    Pairs with the same a are compared together, TOGETHER of them at most or so.
    Only the texts asked for are read again; a set moves once for each group.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("long").alias("groups"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("group"))
    dealt = materialize(dealt, "pairs")
    wanted = dealt.select("a", "group", F.lit(1).alias("role"), F.col("b").alias("key")).unionByName(
        dealt.select("a", "group", F.lit(0).alias("role"), F.col("a").alias("key")).distinct()
    )
    wanted = materialize(wanted.join(classes.select("key", "rep"), "key").select(F.col("rep").alias("doc_id"), "a", "group", "role", "key"), "asked")
    texts = docs.select("doc_id", "text").join(_small(wanted), "doc_id").select("text", "a", "group", "role", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = list(_sets(batch.column(0), width))
                # Another text under the same doc_id has another key.
                own = np.array([len(s) > 0 and set_key(s) == k for s, k in zip(found, batch.column(4).to_pylist(), strict=True)], dtype=bool)
                kept = batch.filter(pa.array(own))
                lists = _lists([s for s, k in zip(found, own, strict=True) if k])
                yield pa.RecordBatch.from_arrays([*kept.columns[1:], lists], names=["a", "group", "role", "key", "elements"])

    sets = texts.mapInArrow(run, "a long, group long, role int, key long, elements array<long>")
    alike = materialize(sets.groupBy("a", "group").applyInArrow(_alike(percent), "a long, b long"), "alike")
    discard(dealt, wanted)
    return alike


def _marks(sketches: list[bytes], size: int) -> np.ndarray:
    """A row of 64-bit words for each sketch: a bit for one or more elements in a bin, one for two or
    more, one for three. Two rows differ in as many bits as their counts differ by."""
    counts = np.stack([folded(x, size) for x in sketches])
    bits = np.packbits(np.concatenate([counts >= 1, counts >= 2, counts >= 3], 1), axis=1)
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def _objects(column: pa.ChunkedArray) -> np.ndarray:
    found = np.empty(len(column), dtype=object)
    found[:] = column.to_pylist()
    return found


def _compare(group: dict[str, np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of a block that can link: an outer class, of role 0, with one of role 1 and another component."""
    key, n, part, outer, role = (group[c] for c in ("key", "n", "component", "outer", "role"))
    mine, others = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    if not len(mine) or not len(others):
        return []
    size = min(map(len, group["counts"]))
    marks, sketches, pairs = _marks(group["counts"], size), group["counts"], []
    key_b, n_b, part_b, outer_b, marks_b = key[others], n[others], part[others], outer[others], marks[others]
    under: dict[int, list[int]] = {}
    for at, k in enumerate(others):
        for hub in group["earlier"][k]:
            under.setdefault(hub, []).append(at)
    met = {hub: np.array(at) for hub, at in under.items()}
    for i in mine:
        # Two outer classes meet in both roles.
        new = (part_b != part[i]) & (~outer_b | (key_b > key[i]))
        for hub in group["earlier"][i]:
            new[met.get(hub, [])] = False
        other = np.flatnonzero(new)
        other = other[_may_link(n_b[other], n[i], np.bitwise_count(marks_b[other] ^ marks[i]).sum(1, dtype=np.int64), percent)]
        for k in others[other]:
            if _may_link(n[k], n[i], _differ(sketches[k], sketches[i]), percent):
                pairs.append((min(key[i], key[k]), max(key[i], key[k])))
    return pairs


def _across(percent: int):
    """``_compare`` for each run of rows with the same hub, i and j; partitions are sorted by them."""
    names = ("key", "n", "component", "outer", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows)
            group = {c: whole.column(c).to_numpy() for c in names} | {c: _objects(whole.column(c)) for c in ("counts", "earlier")}
            marks = np.stack([whole.column(c).to_numpy() for c in ("hub", "i", "j")])
            cuts = np.concatenate([[0], 1 + np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)), [whole.num_rows]])
            pairs = [p for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1 for p in _compare({k: v[a:b] for k, v in group.items()}, percent)]
            both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # The last run of a batch may go on in the next one.
            marks = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("hub", "i", "j")])
            last = int(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0))[-1]) + 1 if (marks[:, 1:] != marks[:, :-1]).any() else 0
            if last:
                yield flush([*held, batch.slice(0, last)])
                held = []
            elif held and any(held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() != int(m[0]) for c, m in zip(("hub", "i", "j"), marks, strict=True)):
                yield flush(held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield flush(held)

    return run


def groups(docs: DataFrame, described: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes, members): key, rep (smallest doc_id), n, counts of each class; hub, key of the
    classes that share a signature whose smallest key is the hub, each once, the hub too."""
    filled = described.filter("n_shingles > 0")
    classes = materialize(
        filled.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("counts").alias("counts")), "classes"
    )
    elements = filled.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, elements // FLUSH)
    dealt = blocks(docs, buckets, width, percent).groupBy("bucket").applyInArrow(_shared(buckets), "signature long, key long")
    shared = materialize(dealt, "shared")
    release(docs.sparkSession)
    hubs = shared.groupBy("signature").agg(F.min("key").alias("hub"))
    # Signatures with the same hub are one group from here on.
    members = materialize(shared.join(hubs, "signature").select("hub", "key").distinct(), "members")
    discard(shared)
    return classes, members


def links(docs: DataFrame, classes: DataFrame, members: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """node, component of the classes that link with another."""
    spark = docs.sparkSession
    sized = classes.select("key", "n", "counts")
    with_a = sized.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    with_b = sized.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    to_hubs = members.filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).join(with_a, "a").join(with_b, "b")
    to_hubs = materialize(to_hubs.filter(_can_link(percent)("na", "ca", "nb", "cb")).select("a", "b"), "hub-pairs")
    release(spark)
    found = _verified(to_hubs, docs, classes, width, percent)
    discard(to_hubs)
    first = materialize(components(found), "hub-components")
    # Groups in which more than the component of the hub is left; the hub has met all others.
    named = members.join(first.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = materialize(named, "named")
    home = F.min(F.when(F.col("key") == F.col("hub"), F.col("component")))
    ends = named.groupBy("hub").agg(home.alias("home"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    split = ends.filter("low < high and size > 2").select("hub", "home")
    rows = named.filter("key <> hub").join(split, "hub").withColumn("outer", F.col("component") != F.col("home")).drop("home")
    # A pair of several groups is compared in that of the smallest hub.
    of_key = members.join(rows.select("key").distinct(), "key").groupBy("key").agg(F.sort_array(F.collect_list("hub")).alias("hubs"))
    rows = rows.join(of_key, "key").withColumn("earlier", F.filter("hubs", lambda h: h < F.col("hub"))).drop("hubs")
    rows = materialize(rows.join(sized, "key"), "rows")
    discard(named, first)
    count = rows.groupBy("hub").agg(
        F.ceil(F.count_if("outer") / BLOCK).cast("int").alias("outer_blocks"), F.ceil(F.count("*") / BLOCK).cast("int").alias("all_blocks")
    )
    rows_in = rows.join(count, "hub")

    def own(blocks: str):
        return F.pmod(F.xxhash64("key"), F.col(blocks)).cast("int")

    def every(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    columns = ["hub", "i", "j", "role", "key", "n", "counts", "component", "outer", "earlier"]
    left = rows_in.filter("outer").withColumns({"i": own("outer_blocks"), "role": F.lit(0)}).withColumn("j", every("all_blocks")).select(columns)
    right = rows_in.withColumns({"j": own("all_blocks"), "role": F.lit(1)}).withColumn("i", every("outer_blocks")).select(columns)
    across = left.unionByName(right).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(_across(percent), "a long, b long")
    across = materialize(across.distinct(), "across")
    discard(rows)
    more = _verified(across, docs, classes, width, percent)
    discard(across)
    linked = materialize(components(found.unionByName(more)), "components")
    discard(found, more)
    return linked


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, key, component (a class, null without words), component_id of each row."""
    ship(docs.sparkSession)
    described = materialize(describe(docs, width), "sets")
    keys = materialize(described.select("doc_id", "n_shingles", "key"), "keys")
    classes, members = groups(docs, described, width, percent)
    discard(described)
    linked = links(docs, classes, members, width, percent)
    discard(members)
    named = classes.select("key", "rep").join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = materialize(named, "class-components")
    discard(classes, linked)
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = named.join(least, "component").select(F.col("key").alias("_key"), "component", "component_id")
    return (
        keys.join(label, F.col("key") == F.col("_key"), "left")
        .select("doc_id", "n_shingles", "key", "component", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of each row."""
    return _labelled(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def _keyed(docs: DataFrame, name: str, width: int) -> DataFrame:
    """``docs`` and the key of each one's set as the last column, null for an empty set."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(s) if len(s) else None for s in _sets(batch.column(text), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def first_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns of ``docs``, and all rows without words.

    It is the row of the smallest doc_id; a null id comes last. Of different
    texts with that doc_id the one of the smallest key stays, of equal ones any.
    """
    rows = materialize(_labelled(docs, width, percent).drop("n_shingles"), "labelled")
    # An id names one row, but for ids that are null or repeated: there the text decides too.
    odd = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")), "odd-ids")
    gone = materialize(rows.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).unionByName(odd.filter("_id is not null")).distinct(), "gone")
    kept = docs.filter("doc_id is not null").join(_small(gone), F.col("doc_id") == F.col("_id"), "left_anti")
    if odd.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    first = rows.filter("key is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_first"))
    name = next(f"_key{k}" for k in range(len(docs.columns) + 1) if f"_key{k}" not in docs.columns)
    texts = materialize(_keyed(docs.join(_small(odd), same, "left_semi"), name, width), "odd-rows")
    firsts = texts.join(first, same & (F.col(name) == F.col("_first")), "left_semi").dropDuplicates(["doc_id", name])
    return kept.unionByName(firsts.unionByName(texts.filter(F.col(name).isNull())).drop(name))


def query(spark, sf_dir):
    """Components of all documents: 4-word shingles, likeness of 85 % or more."""
    return join(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, counted, and the closure of the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id"""
