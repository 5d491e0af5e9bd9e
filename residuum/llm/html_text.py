"""Main text of web pages: markup, and a suffix array over each host's pages.

A page is cut into blocks. Markup says of many what they are: chrome (menus,
headers, footers, sidebars, notices, adverts, forms, comments) or part of the
article. For the rest, and for whole pages without an article element, the host
speaks: the token streams of its pages are concatenated, a suffix array over
them brings equal runs together, and runs of RUN tokens or more that pages of
different content share are boilerplate. What they cover is cut out of blocks
that markup leaves open; unique runs stay.

Articles are copied and quoted on the pages of a host, so repetition alone would
take their text away. Of an article only blocks at its ends go: those that runs
cover as a whole and that stand there on over half of the host's pages of different
content (five at least), unless runs cover all the rest too. Its other blocks
stay whole. How many tokens of a page are covered, and how many are left
out for that, is returned.

A large host's pages are dealt into chunks of CHUNK pages by a hash; their runs
and blocks are counted over the whole host. Host suffix arrays serve hosts of one
chunk, hashes of the same runs the others, with the same result.

A null or empty page has no text. Rows with the same content count as one page
for runs and blocks, so copies don't cancel each other; each row is returned.
Very long pages are read whole, in time that grows in proportion to them. Columns
but page_id, url and html are ignored, whatever their names. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm import text_bytes as tb
from residuum.llm.url_rules import host_of
from residuum.plans.tables import materialize, ship, table

#: Tokens of a run that counts, and pages of different content that must share it.
RUN = 8
MIN_PAGES = 3
CHUNK = 256
#: Compression of parsed pages on their way to their host's tasks; shuffle files take most of the disk.
PACK_LEVEL = 5
#: Blocks at each end of an article that may belong to the template, and pages that must have them there at least.
EDGE = 2
TEMPLATE_PAGES = 5
#: Tokens of a run's parts, and chunks of a large host for each part that its values go to.
GRAM = 5
CHUNKS_A_PART = 16
#: Up to so many hosts of more than CHUNK pages their table is sent to all tasks; more are joined by shuffle.
BROADCAST_HOSTS = 50_000

CHROME, ARTICLE, OPEN = 0, 1, 2
_RADIX = np.uint64(0x5851F42D4C957F2D)

#: Elements whose content is no text of the page at all.
_RAW = frozenset("script style title noscript template iframe object svg canvas audio video".split())
#: Of these, those that swallow the rest of the page if they are never closed.
_TO_THE_END = frozenset("script style title".split())
#: Elements that are chrome, wherever they stand.
_CHROME_TAGS = frozenset("nav footer aside form button select textarea menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
#: Elements that another block ends, as their end tags may be left out.
_LOOSE = frozenset("p dt dd li".split())
#: Words of class, id and role that make an element chrome.
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar pagination pager skip "
    "sidebar side rail widget widgets complementary related recommended recommendations trending popular teaser teasers "
    "footer foot contentinfo masthead topbar header "
    "cookie cookies consent gdpr notice notices alert notification notifications modal popup overlay disclaimer paywall "
    "newsletter subscribe subscription signup login search form "
    "comment comments commentlist disqus respond reply replies share sharing social".split()
)
#: Words that say where something stands or how it is wrapped; beside a chrome word they change nothing,
#: while any other word makes a name one of its own, such as side-effects.
_NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box btn button buttons center column container content count entry group head heading hidden icons image images "
    "inner item items layout left link links list main mobile outer page panel post article posts primary right row secondary section site slot small "
    "space static sticky tabs text thread title tool tools top unit wrap wrapper zone".split()
)
#: Names of an article's own element.
_BODY_NAMES = frozenset("article-body articlebody article-content article-text entry-content post-body post-content story-body".split())
#: Words that make a header one of the article.
_ARTICLE_WORDS = frozenset("article articlebody story post entry content".split())
#: Names that say what else is on the page, such as has-sidebar.
_MODIFIER = re.compile(r"\b(?:has|with|no|without)[-_][\w-]+")
#: Words that make even an article element chrome.
_FOREIGN_ARTICLE = frozenset("comment comments reply replies related teaser promo ad advert sponsored".split())

#: A tag without odd quotes; never looks beyond the next "<" but in quotes that end before it.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*)((?:[^"'<>=]|=(?:"[^"<>]*"|'[^'<>]*')?)*)>""")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NOT_WORD = re.compile(r"[^a-z0-9]+")


def _says(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's own markup makes it chrome, and whether it makes it an article."""
    names: list[set[str]] = []
    hidden = article = False
    if attributes.strip():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden":
                hidden = True
            elif name == "aria-hidden":
                hidden = hidden or value == "true"
            elif name == "style":
                hidden = hidden or "display:none" in value.replace(" ", "")
            elif name == "itemprop":
                article = article or value == "articlebody"
            else:
                article = article or name == "role" and value in ("main", "article")
                names += [set(_NOT_WORD.split(n)) for n in _MODIFIER.sub(" ", value).split()]
                article = article or not _BODY_NAMES.isdisjoint(value.split())
    words = set().union(*names)
    if tag in ("article", "main"):
        foreign = bool(words & _FOREIGN_ARTICLE) and not words & {"post", "entry", "story"}
        return hidden or foreign, not foreign
    if tag in ("html", "body"):
        return False, False
    return hidden or tag in _CHROME_TAGS or any(map(_is_chrome, names)) and not article, article


def _is_chrome(name: set[str]) -> bool:
    """Whether a name's words are chrome words and neutral ones only; an article's header is part of the article."""
    said = {w for w in name if w and not w.isdigit()}
    return bool(said & _CHROME_WORDS - ({"header"} if said & _ARTICLE_WORDS else set())) and said <= _CHROME_WORDS | _NEUTRAL_WORDS | _ARTICLE_WORDS


class _Tags:
    """The tags of a page in order, found in time that grows in proportion to the page."""

    def __init__(self, page: str):
        self.page = page
        self.stops: list[int] | None = None
        self.dead: set[int] = set()
        self.last = page.rfind(">")
        self.unclosed: set[str] = set()

    def _end(self, at: int) -> int:
        """Where the tag's ">" stands, beyond quoted parts; -1 if it has none. From a quote on, all
        tags go on alike, so quotes that led to no end once are remembered."""
        if self.stops is None:
            self.stops = [m.start() for m in _STOP.finditer(self.page)]
        seen = []
        while (k := bisect_left(self.stops, at)) < len(self.stops) and (p := self.stops[k]) not in self.dead:
            if self.page[p] == ">":
                return p
            seen.append(p)
            close = self.page.find(self.page[p], p + 1)
            if close < 0:
                break
            at = close + 1
        self.dead.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" or "", name, attributes) of the next tag or, with "!" for "/", of what is left out."""
        page = self.page
        while 0 <= (start := page.find("<", at)) < self.last or start >= 0 and page.startswith(("<!--", "<![CDATA["), start):
            if m := _PLAIN_TAG.match(page, start):
                return start, m.end(), m[1], m[2], m[3]
            if page.startswith(("<!--", "<![CDATA["), start):
                mark = "-->" if page[start + 2] == "-" else "]]>"
                close = page.find(mark, start + len("<!--" if mark == "-->" else "<![CDATA["))
                return start, len(page) if close < 0 else close + 3, "!", "", ""
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, "!", "", ""
            if (m := _TAG_NAME.match(page, start)) and (end := self._end(m.end())) >= 0:
                return start, end + 1, m[1], m[2], page[m.end() : end]
            at = start + 1
        return None

    def after(self, tag: str, at: int) -> int:
        """Behind the end tag of a raw element, -1 if there is none."""
        if tag not in self.unclosed:
            close = re.compile(rf"</{re.escape(tag)}\b[^<>]*>", re.IGNORECASE).search(self.page, at)
            if close is not None:
                return close.end()
            self.unclosed.add(tag)
        return -1


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, CHROME, ARTICLE or OPEN) of each block in page order; empty ones are left out.

    Without an article on the page all blocks that aren't chrome are open; with
    one, what stands outside is chrome.
    """
    found: list[tuple[list[str], bool, bool, int]] = []
    parts: list[str] = []
    linked = 0
    anchors = 0
    # Open elements: (tag, chrome, article), what holds inside them too.
    stack: list[tuple[str, bool, bool]] = [("", False, False)]

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            found.append((parts, stack[-1][1], stack[-1][2], linked))
            parts, linked = [], 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(references.unescape(raw) if "&" in raw else raw)
            if anchors:
                linked += len(raw.strip())

    # Where in the stack the elements of a name, and all block elements, stand.
    where: dict[str, list[int]] = {}
    block_at = [0]

    def push(element: tuple[str, bool, bool]) -> None:
        where.setdefault(element[0], []).append(len(stack))
        if element[0] in _BLOCK:
            block_at.append(len(stack))
        stack.append(element)

    def drop(k: int) -> None:
        while len(stack) > k:
            name = stack.pop()[0]
            where[name].pop()
            if name in _BLOCK:
                block_at.pop()

    tags, at, size = _Tags(page), 0, len(page)
    while at < size:
        found_tag = tags.next(at)
        if found_tag is None:
            put(page[at:])
            break
        start, end, slash, tag, attributes = found_tag
        put(page[at:start])
        at = end
        if slash == "!":
            continue
        tag = tag.lower()
        empty = page[end - 2] == "/"
        if not slash:
            if tag in _RAW:
                if not empty:
                    close = tags.after(tag, at)
                    at = close if close >= 0 else size if tag in _TO_THE_END else at
                continue
            if tag == "a":
                anchors += 1
            elif tag in _BLOCK:
                end_block()
                while stack[-1][0] in _LOOSE and (tag == stack[-1][0] or stack[-1][0] == "p"):
                    drop(len(stack) - 1)
            elif tag in ("br", "td", "th"):
                parts.append(" ")
            if tag in _VOID or empty:
                continue
            if tag in _BLOCK or tag in _CHROME_TAGS or attributes.strip() and tag != "a":
                chrome, article = _says(tag, attributes)
                _, above_chrome, above_article = stack[-1]
                # An article's own header is part of it; a page's isn't.
                chrome = chrome or tag == "header" and not above_article
                if chrome and not above_chrome and tag not in _BLOCK:
                    end_block()
                push((tag, above_chrome or chrome, above_article or article and not chrome))
        else:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in _BLOCK:
                end_block()
            # An end tag of no block doesn't reach beyond the innermost block.
            if (k := (where.get(tag) or [0])[-1]) > 0 and (tag in _BLOCK or k > block_at[-1]):
                if stack[k][1] and not stack[k - 1][1]:
                    end_block()
                drop(k)
    end_block()
    out = []
    has_article = any(article and not chrome for _, chrome, article, _ in found)
    for texts, chrome, article, in_links in found:
        text = " ".join("".join(texts).split())
        if not text:
            continue
        if chrome or has_article and not article:
            out.append((text, CHROME))
        elif article:
            out.append((text, ARTICLE))
        else:
            # A block of links alone is a menu.
            out.append((text, CHROME if in_links >= 0.8 * len(text) else OPEN))
    return out


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``tokens`` ordered by what follows, and each place's rank, to a depth of ``depth`` tokens at least.

    Prefix doubling: ranks by 1, 2, 4, ... tokens; equal ranks, equal prefixes.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    rank, span = rank.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while span < depth:
        step = min(span, depth - span)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] if step < len(rank) else 0
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(len(rank), dtype=np.int64)
        ordered = key[order]
        new[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])]) if len(rank) else 0
        rank, span = new, span + step
        if len(rank) and rank.max() == len(rank):
            break
    return order, rank


def repeated(streams: list[np.ndarray], run: int = RUN, pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For each token of each stream whether it lies in a run of ``run`` tokens that
    ``pages`` streams of different content share."""
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    if not lengths.sum():
        return [np.zeros(len(s), dtype=bool) for s in streams]
    content = {}
    same = np.array([content.setdefault(s.tobytes(), len(content)) for s in streams])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    # Every stream ends in a token of its own.
    _, codes = np.unique(np.concatenate(streams), return_inverse=True)
    tokens = np.empty(starts[-1], dtype=np.int64)
    page = np.repeat(np.arange(len(streams)), lengths + 1)
    ends = starts[1:] - 1
    body = np.ones(len(tokens), dtype=bool)
    body[ends] = False
    tokens[body] = codes + len(streams)
    tokens[ends] = np.arange(len(streams))
    order, rank = suffix_array(tokens, run)
    # Pages of different content by group of equal prefixes; prefixes with a stream's end are alone.
    pair = np.unique(rank[order] * (len(streams) + 1) + same[page[order]])
    group, n = np.unique(pair // (len(streams) + 1), return_counts=True)
    shared = np.zeros(int(rank.max()) + 1, dtype=bool)
    shared[group[n >= pages]] = True
    begins = shared[rank]
    cover = np.cumsum(np.concatenate([begins, np.zeros(run, dtype=bool)]).astype(np.int64))
    before = np.concatenate([np.zeros(run, dtype=np.int64), cover])[: len(begins)]
    covered = cover[: len(begins)] - before > 0
    return [covered[a : a + k] for a, k in zip(starts[:-1], lengths, strict=True)]


def content(stream: np.ndarray) -> np.uint64:
    """A hash of a whole stream."""
    return np.uint64(int.from_bytes(hashlib.blake2b(stream.tobytes(), digest_size=8).digest(), "little"))


def runs(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of RUN tokens its place in the joined streams, its stream, its hash and its least part's hash."""
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    joined = np.concatenate([*streams, np.zeros(0, np.uint64)]).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    n, step = max(0, len(joined) - GRAM + 1), RUN - GRAM
    parts = np.zeros(n, np.uint64)
    for k in range(GRAM):
        parts = tb.mix64(parts * _RADIX + joined[k : k + n] + np.uint64(k + 1))
    n = max(0, n - step)
    at = np.flatnonzero(np.arange(n) + RUN <= ends[:n])
    least = parts[:n]
    for k in range(1, step + 1):
        least = np.minimum(least, parts[k : k + n])
    # The first and the last part cover the run.
    whole = tb.mix64(parts[:n] * _RADIX + parts[step : step + n])
    return at, np.repeat(np.arange(len(streams)), lengths)[at], whole[at], tb.mix64(least[at])


def _few(values: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, at most MIN_PAGES of each value, ordered by value."""
    order = np.lexsort((who, values))
    values, who = values[order], who[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (who[1:] != who[:-1])
    values, who = values[new], who[new]
    kept = np.ones(len(values), dtype=bool)
    kept[MIN_PAGES:] = values[MIN_PAGES:] != values[:-MIN_PAGES]
    return values[kept], who[kept]


def _name(text: str) -> int:
    """A block's, or a page's, 64-bit name, above 0."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 | 1


def _outer(article: list[str]) -> set[str]:
    """The first and the last EDGE blocks of an article that has others."""
    return set(article[:EDGE] + article[-EDGE:]) if len(article) > 1 else set()


def _template(article: list[tuple[str, bool]], wide: set[int]) -> tuple[int, int]:
    """The article without blocks at its ends that belong to the host's template, as (first, end).

    Such a block is covered by repeated runs as a whole and stands at the ends of
    most of the host's articles. If all that would be left is covered too, the
    article is a copy and stays whole.
    """
    first, end = 0, len(article)
    while first < min(EDGE, end - 1) and article[first][1] and _name(article[first][0]) in wide:
        first += 1
    while end > max(len(article) - EDGE, first + 1) and article[end - 1][1] and _name(article[end - 1][0]) in wide:
        end -= 1
    return (0, len(article)) if all(whole for _, whole in article[first:end]) else (first, end)


def _text(texts: list[str], states: list[int], covered: np.ndarray, wide: set[int]) -> tuple[str, int]:
    """Blocks of the article but for those of the host's template, and of open ones what isn't covered,
    joined in page order; and how many tokens were left out for the runs that the host repeats."""
    ends = np.cumsum([len(text.split(" ")) for text in texts], dtype=np.int64)
    marks = np.split(covered, ends[:-1]) if len(texts) else []
    article = [(text, bool(own.all())) for text, state, own in zip(texts, states, marks, strict=True) if state == ARTICLE]
    first, end = _template(article, wide) if wide else (0, len(article))
    out, cut, at = [], 0, 0
    for text, state, own in zip(texts, states, marks, strict=True):
        if state == ARTICLE:
            at += 1
            if first < at <= end:
                out.append(text)
            else:
                cut += len(own)
        elif state == OPEN:
            cut += int(own.sum())
            if not own.any():
                out.append(text)
            elif left := " ".join(w for w, c in zip(text.split(" "), own, strict=True) if not c):
                out.append(left)
    return "\n\n".join(out), cut


def _tokens(texts: list[str]) -> np.ndarray:
    """One number for each space-separated word of the blocks."""
    joined = pa.array([" ".join(texts)])
    found = [tb.word_hashes(data, offsets)[0] for _, data, offsets in tb.chunks(joined)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each host and chunk of a batch, with its parsed pages."""
    kinds = pa.list_(pa.string()), pa.list_(pa.int8())
    for batch in batches:
        where: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_host", "_chunk", "_chunks")), strict=True)):
            where.setdefault(key, []).append(k)
        packed = []
        for rows in where.values():
            own = batch.take(pa.array(rows))
            found = [blocks(page.as_py() or "") for page in own.column("html")]
            texts, states = [[t for t, _ in f] for f in found], [[s for _, s in f] for f in found]
            columns = [own.column("page_id"), own.column("url"), pa.array(texts, kinds[0]), pa.array(states, kinds[1])]
            packed.append(_pack(pa.Table.from_arrays(columns, names=["page_id", "url", "texts", "states"])))
        keys = [pa.array([key[k] for key in where], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(packed, pa.binary())], names=["_host", "_chunk", "_chunks", "pages"])


def _pack(pages: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pages.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", PACK_LEVEL))) as out:
        out.write_table(pages)
    return sink.getvalue().to_pybytes()


def _unpack(packed: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(p.as_buffer()).read_all() for p in packed.column("pages"))


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


_SENT = "_host string, _part long, _chunk long, values binary, who binary"
_BACK = "_host string, _chunk long, values binary"
_ENDS = "_host string, chunks long, block long, page long"


def _send(packed: pa.Table, values: np.ndarray, who: np.ndarray, part: np.ndarray) -> pa.Table:
    """A row for each part that has values."""
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    groups = np.split(order, first[1:]) if len(parts) else []
    host, chunk = packed.column("_host")[0].as_py(), packed.column("_chunk")[0].as_py()
    columns = [[host] * len(groups), parts.tolist(), [chunk] * len(groups), [values[g].tobytes() for g in groups], [who[g].tobytes() for g in groups]]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_host", "_part", "_chunk", "values", "who"])


def _parts_of(packed: pa.Table) -> np.uint64:
    """Parts of a host's values, 0 if it has one chunk."""
    chunks = packed.column("_chunks")[0].as_py() if len(packed) else 1
    return np.uint64(-(-chunks // CHUNKS_A_PART) if chunks > 1 else 0)


_NONE = np.zeros(0, np.uint64)
_HALF = np.uint64(32)


def _streams(packed: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Token streams of a chunk's pages, and the hashes of their contents."""
    streams = [_tokens(t) for t in _unpack(packed).column("texts").to_pylist()]
    return streams, np.array([content(s) for s in streams], dtype=np.uint64)


def _key(least: np.ndarray, parts: np.uint64) -> np.ndarray:
    """Part in the upper half, 32 bits of the value in the lower."""
    return ((least >> _HALF) % parts << _HALF) | (least & np.uint64(0xFFFFFFFF))


def _first(packed: pa.Table) -> pa.Table:
    """Least parts of all runs, as often as pages of different content of the chunk have them."""
    parts = _parts_of(packed)
    if not parts:
        return _send(packed, _NONE, _NONE, _NONE)
    streams, contents = _streams(packed)
    _, page, _, least = runs(streams)
    keys, _ = _few(_key(least, parts), contents[page])
    return _send(packed, keys.astype(np.uint32), np.zeros((len(keys), 0), np.uint8), (keys >> _HALF).astype(np.int64))


def _often(sent: pa.Table) -> pa.Table:
    """To each chunk those of its values that may be on MIN_PAGES pages; contents of several chunks count in each."""
    values = _joined(sent.column("values"), np.uint32)
    found, n = np.unique(values, return_counts=True)
    return _answer(sent, found[n >= MIN_PAGES], np.uint32)


def _answer(sent: pa.Table, shared: np.ndarray, kind: type) -> pa.Table:
    part = np.uint64(sent.column("_part")[0].as_py()) << _HALF
    chunks, out = [], []
    for chunk, own in zip(sent.column("_chunk").to_pylist(), sent.column("values").to_pylist(), strict=True):
        both = np.intersect1d(np.frombuffer(own, dtype=kind), shared)
        if len(both):
            chunks.append(chunk)
            out.append((both.astype(np.uint64) | part if kind is np.uint32 else both).tobytes())
    return pa.Table.from_arrays([pa.array([sent.column("_host")[0].as_py()] * len(out), pa.string()), pa.array(chunks, pa.int64()), pa.array(out, pa.binary())], names=["_host", "_chunk", "values"])


def _second(packed: pa.Table, back: pa.Table) -> pa.Table:
    """Runs whose least part may be on enough pages, with the contents that have them."""
    parts = _parts_of(packed)
    if not parts or not len(back):
        return _send(packed, _NONE, _NONE, _NONE)
    streams, contents = _streams(packed)
    _, page, whole, least = runs(streams)
    may = np.isin(_key(least, parts), _joined(back.column("values"), np.uint64))
    values, who = _few(whole[may], contents[page[may]])
    order = np.argsort(who, kind="stable")
    values, who = values[order], who[order]
    return _send(packed, values, who, ((values >> _HALF) % parts).astype(np.int64))


def _shared(sent: pa.Table) -> pa.Table:
    """To each chunk those of its runs that MIN_PAGES pages of different content share."""
    values, _ = _few(_joined(sent.column("values"), np.uint64), _joined(sent.column("who"), np.uint64))
    found, n = np.unique(values, return_counts=True)
    return _answer(sent, found[n >= MIN_PAGES], np.uint64)


def _covered(streams: list[np.ndarray], shared: np.ndarray) -> list[np.ndarray]:
    """For each token of each stream whether it lies in one of the shared runs."""
    at, _, whole, _ = runs(streams)
    ends = np.cumsum([len(s) for s in streams])
    begins = at[np.isin(whole, shared)]
    change = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + RUN, -1)
    return np.split(np.cumsum(change[:-1]) > 0, ends[:-1])


def _ends(packed: pa.Table) -> pa.Table:
    """The blocks at the ends of a chunk's articles, each once for each page of different content; 0 stands for the page itself."""
    found = set()
    pages = _unpack(packed)
    for texts, states in zip(pages.column("texts").to_pylist(), pages.column("states").to_pylist(), strict=True):
        article = [t for t, s in zip(texts, states, strict=True) if s == ARTICLE]
        if article:
            page = _name("\n".join(texts))
            found |= {(0, page)} | {(_name(t), page) for t in _outer(article)}
    host, chunks = packed.column("_host")[0].as_py(), packed.column("_chunks")[0].as_py()
    columns = [[host] * len(found), [chunks] * len(found), [b for b, _ in found], [p for _, p in found]]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_host", "chunks", "block", "page"])


def _wide(ends: DataFrame) -> DataFrame:
    """To each chunk the blocks that stand at the ends of most articles of its host; a host has at most four times EDGE."""
    # Both sides of the join read one exchange, as neither's condition reaches below the counts.
    counts = ends.distinct().groupBy("_host", "block").agg(F.count("*").alias("n"), F.max("chunks").alias("chunks"), F.max(F.col("block") == 0).alias("all"))
    of_host = counts.filter("all").select("_host", F.col("n").alias("pages"))
    wide = counts.filter(~F.col("all") & (F.col("n") >= TEMPLATE_PAGES)).join(of_host, "_host").filter("n * 2 > pages")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    return wide.select("_host", each.alias("_chunk"), F.lit(None).cast("binary").alias("values"), "block")


def _by_host(packed: pa.Table, back: pa.Table) -> pa.Table:
    pages = _unpack(packed)
    texts, states = pages.column("texts").to_pylist(), pages.column("states").to_pylist()
    streams = [_tokens(t) for t in texts]
    runs_back = back.filter(pc.is_null(back.column("block")))
    marks = _covered(streams, _joined(runs_back.column("values"), np.uint64)) if _parts_of(packed) else repeated(streams)
    wide = set(back.column("block").drop_null().to_pylist())
    out = [_text(t, s, m, wide) for t, s, m in zip(texts, states, marks, strict=True)]
    return (
        pages.select(["page_id", "url"])
        .append_column("text", pa.array([t for t, _ in out], pa.string()))
        .append_column("n_chars", pa.array([len(t) for t, _ in out], pa.int64()))
        .append_column("n_tokens", pa.array([len(s) for s in streams], pa.int64()))
        .append_column("n_repeated", pa.array([int(m.sum()) for m in marks], pa.int64()))
        .append_column("n_cut", pa.array([n for _, n in out], pa.int64()))
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row, with its tokens, how many of them the host repeats
    and how many are left out for that (n_cut)."""
    ship(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    host = host_of(F.col("url"))
    large = materialize(pages.groupBy(host.alias("_large")).count().filter(F.col("count") > CHUNK), "large-hosts")
    beside = F.broadcast(large) if large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else large
    chunks = F.ceil(F.coalesce("count", F.lit(1)) / CHUNK).cast("long")
    dealt = (
        pages.select("page_id", "url", "html", host.alias("_host")).join(beside, F.col("_host") == F.col("_large"), "left")
        .select("page_id", "url", "_host", F.pmod(F.xxhash64("page_id", "url"), chunks).alias("_chunk"), chunks.alias("_chunks"), "html")
    )
    # The packed pages are shuffled once; all three passes read the same exchange.
    packed = dealt.mapInArrow(_parse, "_host string, _chunk long, _chunks long, pages binary")
    of_chunk = lambda: packed.groupBy("_host", "_chunk")
    often = of_chunk().applyInArrow(_first, _SENT).groupBy("_host", "_part").applyInArrow(_often, _BACK)
    second = of_chunk().cogroup(often.groupBy("_host", "_chunk")).applyInArrow(_second, _SENT)
    shared = second.groupBy("_host", "_part").applyInArrow(_shared, _BACK)
    wide = _wide(of_chunk().applyInArrow(_ends, _ENDS))
    back = shared.withColumn("block", F.lit(None).cast("long")).unionByName(wide)
    rows = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_tokens long, n_repeated long, n_cut long"
    return of_chunk().cogroup(back.groupBy("_host", "_chunk")).applyInArrow(_by_host, rows)


def query(spark, sf_dir):
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The article of this template, for pages that have one: blocks are h1 and p, references those of the table.
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS body FROM pages),
b AS (
  SELECT page_id, url, [trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;', '''', 'g'),
    '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) FOR x IN string_split_regex(body, '</?(?:h1|p)>')] AS parts FROM a),
c AS (SELECT page_id, url, coalesce(array_to_string([x FOR x IN parts IF x <> ''], chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c"""
