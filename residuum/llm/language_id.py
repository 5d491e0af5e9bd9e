"""Language identification by Bayesian evidence fusion.

The text speaks through hashed byte trigrams: a language's likelihood of each
comes from a bounded sample of texts that declare it. Three more kinds of
evidence join it in one posterior, all counted over the whole corpus by grouped
aggregation: how often texts of a language declare which language, on which
address suffixes it stands, and how its share varies by host, where a host
leans on its domain and the domain on the corpus as far as its own counts are
few. One more class, "und", has the trigrams of no language.

Every declared language is a class; "EN", "en" and "en-US" are one. Declarations
and suffixes that are too rare for counts of their own share those of one pool.

A text without letters has no language: "und", rejected. A null, empty or "und"
declaration and a null suffix or host are no evidence. Very long texts are read whole. Of equal
posteriors the language that comes first by name wins. Repeated rows count as often as they stand.
The filter keeps columns of any names apart in a struct; other columns are ignored. No rows in, no rows out.
Without any declared language no text gets one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm import text_bytes as tb
from residuum.plans.tables import materialize, ship, table

#: Bound of the labelled sample: texts for each language.
SAMPLE = 1500
BITS = 15
SEED = 23
UND = "und"
#: Trigrams overlap and repeat: so much of one counts as independent evidence, and a text's weight grows no further from so many nats a language.
TEMPER = 0.25
#: Pseudo-counts of declarations and suffixes, and of the domain behind a host and the corpus behind a domain.
PSEUDO = 0.5
LEAN = 20.0
#: A suffix that is rarer than so many most frequent ones counts as OTHER; so does a declaration, unless it names a class.
OWN_COUNTS = 2000
OTHER = ""
#: The share of "und" before any evidence, and the posterior that a text needs.
UND_PRIOR = 1e-4
KEEP_FROM = 0.5
#: Up to so many hosts their table is sent to all tasks; more are joined by shuffle.
BROADCAST_HOSTS = 50_000


@dataclass(frozen=True)
class TextModel:
    """log P(bucket | language) for each language, in their order, and of no language."""

    languages: tuple[str, ...]
    weights: np.ndarray = field(repr=False)


def language_of(declared: Column) -> Column:
    """A declaration's language: lower case, without region or script; null if it names none."""
    first = F.regexp_extract(F.lower(declared), r"^\s*([^\s_-]+)", 1)
    return F.when(~first.isin("", UND), first)


def learn_text(docs: DataFrame, text: str = "text", declared: str = "lang", row_id: str = "doc_id") -> TextModel:
    """Trigram likelihoods from SAMPLE texts or so of each declared language.

    The sample goes by a hash of the row's id and text; equal texts count once.
    """
    ship(docs.sparkSession)
    seen = docs.groupBy(language_of(F.col(declared)).alias("lang")).count().filter("lang is not null")
    sizes = {r["lang"]: r["count"] for r in seen.collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return TextModel((), np.zeros((1, 1 << BITS), np.float32))
    share = _literal({k: min(1.0, SAMPLE / n) for k, n in sizes.items()}, "double")
    draw = F.pmod(F.xxhash64(F.col(row_id), F.lit(SEED)), F.lit(1 << 20)) / float(1 << 20)
    picked = docs.filter(draw < F.try_element_at(share, language_of(F.col(declared))))
    picked = picked.select(language_of(F.col(declared)).alias("lang"), F.col(text).alias("text")).filter("text is not null").dropDuplicates(["text"])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for row, data, offsets in tb.chunks(batch.column(1)):
                start, end = tb.inside(offsets)
                buckets = tb.gram_buckets(tb.LETTERS[data], BITS)
                for k, (a, b) in enumerate(zip(start, end, strict=True)):
                    own = total.setdefault(langs[row + k], np.zeros(1 << BITS, np.int64))
                    own += np.bincount(buckets[a:b], minlength=1 << BITS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = picked.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((len(languages) + 1, 1 << BITS), 0.2)
    found = counted.toArrow()
    place = {k: i for i, k in enumerate(languages)}
    rows = np.array([place[k] for k in found.column("lang").to_pylist()], dtype=np.int64)
    counts[rows, found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    counts[-1] = 1.0
    return TextModel(languages, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def text_scores(text: Column, model: TextModel) -> Column:
    """struct(letters, ll): trigrams with letters, and their log-likelihood by language, "und" last."""
    spaces = tb.gram_buckets(np.full(3, 32, np.uint8), BITS)[0]
    weights, n = model.weights, len(model.languages) + 1

    @F.arrow_udf("letters long, ll array<double>")
    def score(texts: pa.Array) -> pa.Array:
        letters, ll = [np.zeros(0)], [np.zeros((0, n))]
        for _, data, offsets in tb.chunks(texts):
            start, end = tb.inside(offsets)
            # Runs of spaces and signs say nothing about the language.
            buckets = tb.gram_buckets(tb.LETTERS[data], BITS)
            live = buckets != spaces
            letters.append(tb.sums(live, start, end))
            ll.append(np.stack([tb.sums(np.where(live, w[buckets], 0.0), start, end) for w in weights], 1))
        letters, ll = np.concatenate(letters), np.concatenate(ll)
        lists = pa.ListArray.from_arrays(np.arange(0, n * len(ll) + 1, n, dtype=np.int32), pa.array(ll.ravel()))
        return pa.StructArray.from_arrays([pa.array(letters.astype(np.int64)), lists], names=["letters", "ll"])

    return score(text)


def suffix_of(host: Column) -> Column:
    """What follows the last dot of a host, null if it has none."""
    return F.nullif(F.regexp_extract(F.lower(host), r"\.([^.]+)\.?$", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host, the host itself if it has fewer."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(host), r"([^.]+\.[^.]+)\.?$", 1), F.lit("")), F.lower(host))


@dataclass(frozen=True)
class Evidence:
    """Log-likelihoods of declarations and suffixes by language, and the hosts' priors."""

    declared: dict[str, list[float]]
    suffix: dict[str, list[float]]
    corpus: list[float]
    hosts: DataFrame
    n_hosts: int


def _by_text(model: TextModel) -> Column:
    """Place of the language that the text alone speaks for; null without letters or for "und"."""
    ll = F.col("text_says.ll")
    best = F.array_position(ll, F.array_max(ll)).cast("int") - 1
    return F.when((F.col("text_says.letters") > 0) & (best < len(model.languages)), best)


def learn_evidence(scored: DataFrame, model: TextModel) -> Evidence:
    """Count what texts of each language declare, and on which suffixes and hosts they stand.

    ``scored`` has text_says, declared, suffix and host, any of the last three null.
    """
    n = len(model.languages)
    cube = materialize(
        scored.select("declared", "suffix", "host", _by_text(model).alias("k")).filter("k is not null")
        .groupBy("declared", "suffix", "host", "k").agg(F.count("*").alias("n")),
        "language-counts",
    )

    def counts(frame: DataFrame, *keys: str) -> DataFrame:
        """keys, n, and "by", the entries of n by k."""
        by_k = frame.groupBy(*keys, "k").agg(F.sum("n").alias("n"))
        return by_k.groupBy(*keys).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", F.col("n").cast("double")))).alias("by"))

    def listed(by: dict[int, float]) -> list[float]:
        return [by.get(k, 0.0) for k in range(n)]

    def table_of(column: str) -> dict[str, list[float]]:
        known = cube.filter(F.col(column).isNotNull() & (F.col(column) != OTHER))
        each = counts(known, column)
        top = each.orderBy(F.desc("n"), column).limit(OWN_COUNTS).collect()
        if column == "declared":
            top += each.filter(F.col(column).isin(*model.languages)).collect()
        rows = {r[0]: listed(r["by"]) for r in top}
        whole = counts(known).collect()
        whole = listed(whole[0]["by"] if whole and whole[0]["by"] else {})
        rows[OTHER] = [whole[k] - sum(r[k] for r in rows.values()) for k in range(n)]
        columns = [x + PSEUDO * len(rows) for x in whole]
        # "und" declares anything, evenly.
        return {v: [math.log((r[k] + PSEUDO) / columns[k]) for k in range(n)] + [-math.log(len(rows))] for v, r in rows.items()}

    whole = counts(cube).first()
    total = listed(whole["by"] if whole and whole["by"] else {})
    share = [(x + 1) / (sum(total) + n) for x in total]
    corpus = [x * (1 - UND_PRIOR) for x in share] + [UND_PRIOR]
    dense = F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), lambda k: F.coalesce(F.try_element_at("by", k), F.lit(0.0))).alias("by")
    on_hosts = cube.filter("host is not null").withColumn("domain", domain_of(F.col("host")))
    by_host = counts(on_hosts, "host", "domain").select("host", "domain", dense)
    by_domain = counts(on_hosts, "domain").select("domain", dense.alias("up"))
    added = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    lean = F.array(*(F.lit(LEAN * p) for p in share)) if n else F.array(F.lit(0.0))
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    domains = by_domain.select("domain", F.transform(added(F.col("up"), lean), lambda x: LEAN * x / (size(F.col("up")) + LEAN)).alias("up"))
    prior = F.transform(added(F.col("by"), F.col("up")), lambda x: F.log(x / (size(F.col("by")) + LEAN) * (1 - UND_PRIOR)))
    hosts = materialize(by_host.join(domains, "domain").select(F.col("host").alias("_host"), prior.alias("_prior")), "language-hosts")
    return Evidence(table_of("declared"), table_of("suffix"), [math.log(x) for x in corpus], hosts, hosts.count())


def _literal(rows: dict, kind: str = "array<double>") -> Column:
    import json

    return F.from_json(F.lit(json.dumps(rows)), f"map<string,{kind}>")


def _says(rows: dict[str, list[float]], value: Column, none: Column) -> Column:
    """A value's row, that of OTHER if it has none; nothing for null or an empty value."""
    known = _literal(rows)
    return F.when(value.isNull() | (value == OTHER), none).otherwise(F.coalesce(F.try_element_at(known, value), F.try_element_at(known, F.lit(OTHER))))


def fuse(scored: DataFrame, model: TextModel, evidence: Evidence) -> DataFrame:
    """Add ``language``, ``posterior`` and ``kept`` to scored rows; their evidence stays."""
    hosts = F.broadcast(evidence.hosts) if evidence.n_hosts <= BROADCAST_HOSTS else evidence.hosts
    joined = scored.join(hosts, F.col("host") == F.col("_host"), "left")
    n = len(model.languages) + 1
    none = F.array(*(F.lit(0.0) for _ in range(n)))
    corpus = F.array(*map(F.lit, evidence.corpus))
    host = F.concat(F.coalesce("_prior", F.slice(corpus, 1, n - 1)), F.array(F.lit(evidence.corpus[-1]))) if n > 1 else corpus
    parts = [
        F.transform(F.col("text_says.ll"), lambda x: TEMPER * x),
        host,
        _says(evidence.declared, F.col("declared"), none),
        _says(evidence.suffix, F.col("suffix"), none),
    ]
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda x, y: x + y)
    names = F.array(*map(F.lit, [*model.languages, UND]))
    out = joined.withColumn("_total", total).withColumn("_top", F.array_max("_total"))
    weight = F.aggregate(F.transform("_total", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, b: a + b)
    best = F.get(names, F.array_position("_total", F.col("_top")).cast("int") - 1)
    some = F.col("text_says.letters") > 0
    return (
        out.withColumn("language", F.when(some, best).otherwise(F.lit(UND)))
        .withColumn("posterior", F.when(some, 1 / weight).otherwise(F.lit(0.0)))
        .withColumn("kept", some & (F.col("language") != UND) & (F.col("posterior") >= KEEP_FROM))
        .drop("_host", "_prior", "_total", "_top")
    )


def _evidence_of(docs: DataFrame) -> list[Column]:
    """declared, suffix and host as a document's own columns have them."""
    return [language_of(docs["lang"]).alias("declared"), suffix_of(docs["source"]).alias("suffix"), F.lower(docs["source"]).alias("host")]


def filter_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with their columns.

    Texts are scored once and written beside their rows; evidence is counted
    and rows are judged from there. Texts are never shuffled.
    """
    model = learn_text(docs)
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text_scores(docs["text"], model).alias("text_says"), *_evidence_of(docs))
    scored = materialize(held, "language-scored", lent=True)
    return fuse(scored, model, learn_evidence(scored, model)).filter("kept").select("row.*")


def page_evidence(pages: DataFrame) -> DataFrame:
    """doc_id, page_declared, page_suffix, page_host: the markup language and the address of
    each document's first page. The number that ends a page's path is its document's id."""
    from residuum.llm.url_rules import host_of, path_of

    host = host_of(F.col("url"))
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.html?)?/?$", 1).try_cast("long")
    # Comments and scripts may show tags that aren't the page's.
    shown = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)", " ")
    markup = F.regexp_extract(shown, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)
    found = pages.select(number.alias("doc_id"), F.struct("page_id", language_of(markup).alias("page_declared"), suffix_of(host).alias("page_suffix"), F.nullif(host, F.lit("")).alias("page_host")).alias("page"))
    return found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("page").alias("page")).select("doc_id", "page.page_declared", "page.page_suffix", "page.page_host")


def query(spark, sf_dir):
    """Every document's language: its text, its page's markup and address where it
    has a page, and its own declaration and source where it has none."""
    docs = table(spark, sf_dir, "documents")
    model = learn_text(docs)
    texts = materialize(docs.select("doc_id", *_evidence_of(docs), text_scores(docs["text"], model).alias("text_says")), "language-texts")
    beside = page_evidence(table(spark, sf_dir, "pages"))
    scored = materialize(
        texts.join(beside, "doc_id", "left").select(
            "doc_id", "text_says",
            F.coalesce("page_declared", "declared").alias("declared"),
            F.coalesce("page_suffix", "suffix").alias("suffix"),
            F.coalesce("page_host", "host").alias("host"),
        ),
        "language-evidence",
    )
    return fuse(scored, model, learn_evidence(scored, model)).select("doc_id", "language", "posterior", "declared", "suffix", "host", "kept")
