import random
import time

import duckdb
import numpy as np

from residuum.llm import html_text as H


def test_runs_match_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        streams = [np.array([rng.randrange(3) for _ in range(rng.randrange(0, 30))], dtype=np.uint64) for _ in range(rng.randrange(1, 7))]
        run, pages = rng.randrange(1, 6), rng.randrange(2, 4)
        where = {}
        for s in streams:
            for k in range(len(s) - run + 1):
                where.setdefault(s[k : k + run].tobytes(), set()).add(s.tobytes())
        for s, found in zip(streams, H.repeated(streams, run, pages), strict=True):
            covered = np.zeros(len(s), dtype=bool)
            for k in range(len(s) - run + 1):
                if len(where[s[k : k + run].tobytes()]) >= pages:
                    covered[k : k + run] = True
            assert (found == covered).all()


def text(page):
    return "\n\n".join(t for t, s in H.blocks(page) if s != H.CHROME)


def test_markup():
    assert text("<html><body><nav>Home</nav><article><h1>T &amp; t</h1><p>a\n <b>b</b><br>c<p>d &lt;e&gt; &#233;</article><footer>f</footer>") == "T & t\n\na b c\n\nd <e> é"
    assert text("<body><header><h1>Site</h1></header><main><header><h1>T</h1></header><p>x<aside>side</aside>y</p></main>") == "T\n\nx\n\ny"
    assert text('<body><div class="content post-7"><p>x</p><div class="ad-box">buy</div><div id="comments"><p>c</p></div></div>') == "x"
    assert text('<article><p>x</p><div class=cookie-notice>n</div><form>f<input></form><section class="comments"><article class="comment">c</article></section></article>') == "x"
    assert text('<body><div class="sidebar">s</div><p hidden>h</p><p style="display: none">h</p><p>x</p>') == "x"
    assert text("<p>a<script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no</p> -->b</p>") == "ab"
    assert text('<ul><li><a href="/x">Menu one</a></li><li><a>Two</a></ul><p>see <a>this link</a> and more</p>') == "see this link and more"
    assert text("<p>5 < 6 & 7 &am &unknown;</p>") == "5 < 6 & 7 &am &unknown;"
    assert text('<html><head><title>T</title><body class="has-sidebar"><div class="content-area with-sidebar"><p>x</p><div class="main-menu">m</div><div class="post-header"><h1>h</h1></div><div class="entry-footer">f</div></div>') == "x\n\nh"
    assert text("<p>a</p><noscript>never closed<p>b</p>") == "a\n\nnever closed\n\nb"
    assert text("") == "" and text("<!-- never closed") == "" and text("plain") == "plain"
    assert text("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == "a b\n\nc"


def test_host_boilerplate_is_cut_from_open_blocks(spark):
    line = "all rights reserved by the owners of this very site and its many friends"
    rows = [(k, f"http://h.com/{k}", f"<div><div>unique text number {k} about topic {k * 7}</div><div>{line}</div></div>") for k in range(6)]
    rows += [(50 + k, f"http://h.com/c{k}", f"<article><p>{line}</p></article>") for k in range(4)]
    rows += [(90, None, f"<p>{line}</p>"), (91, "http://other.com/", f"<p>{line}</p>"), (92, "http://h.com/", None), (None, None, ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    out = H.extract(df).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert all(by[k]["text"] == f"unique text number {k} about topic {k * 7}" for k in range(6))
    assert all(by[50 + k]["text"] == line and by[50 + k]["n_repeated"] == len(line.split()) for k in range(4))
    assert by[90]["text"] == by[91]["text"] == line and by[92]["text"] == by[None]["text"] == "" and by[91]["n_chars"] == len(line)
    assert H.extract(df.limit(0)).count() == 0


def test_names_count_as_wholes():
    inner = '<p>a</p><div class="side-effects"><p>b</p></div><section id="discussion"><p>c</p></section><div class="ad-hoc-networks"><p>d</p></div>'
    page = f'<article>{inner}<section class="social-policy"><p>e</p></section><p>f <math><mi>x</mi></math> g</p></article><div class="article-body"><p>h</p></div>'
    assert text(page).split("\n\n") == ["a", "b", "c", "d", "e", "f x g", "h"]
    link = "a whole sentence that is one long link, " * 9
    assert text(f"<p><a href=x>{link}</a></p><p>text</p>") == "text"


def test_hostile_pages_take_linear_time():
    start = time.time()
    for page in ("<a " * 350_000, "<a '" * 250_000, "<div>" * 16_000 + "</section>" * 16_000, "<svg>" * 200_000, "<b x><div>" + "<span x>" * 60_000 + "</b>" * 60_000,
                 "<!x" * 300_000, "<a " * 200_000 + "'>", '<p class="' * 60_000 + ">", "<a '\"<b \"'" * 100_000):
        H.blocks(page)
    assert time.time() - start < 15
    assert text("<p>a <b title='x>y'>c</b> d < e <i title=\"open>f</p>") == 'a c d < e <i title="open>f'


def test_template_blocks_leave_articles(spark, monkeypatch):
    words = lambda a, k: " ".join(f"{a}{k}x{i}" for i in range(12))
    line, licence, quote = words("share", 0), words("licence", 0), words("quote", 0)
    rows = []
    for k in range(12):
        body = [words("first", k), words("second", k), words("third", k)]
        # Two pages of the host are copies of others; a licence ends few articles; a quote stands in the middle of all.
        body = [words(w, k - 10) for w in ("first", "second", "third")] if k >= 10 else body
        body.insert(2, quote)
        body += [licence] * (k < 4) + [line]
        rows.append((k, f"http://h.com/{k}", "<article>" + "".join(f"<p>{b}</p>" for b in body) + f"</article><footer>{words('foot', k)}</footer>"))
    # A host of copies: all is repeated, nothing goes.
    rows += [(100 + k, f"http://copies.com/{k}", f"<article><p>{words('one', 0)}</p><p>{words('two', 0)}</p><p>tail</p></article><p>{words('x', k)}</p>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted(H.extract(df).collect())
    monkeypatch.setattr(H, "CHUNK", 5)
    assert sorted(H.extract(df).collect()) == found
    by = {r["page_id"]: r for r in found}
    for k in range(12):
        assert line not in by[k]["text"] and quote in by[k]["text"] and by[k]["n_cut"] == 12
        assert (licence in by[k]["text"]) == (k < 4) and words("first", k % 10) in by[k]["text"]
    assert all(by[100 + k]["n_cut"] == 0 and by[100 + k]["text"].count("\n\n") == 2 for k in range(9))


def test_query_matches_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view pages as from '{data}/pages.parquet'")
    expected = {r[0]: r[1:] for r in con.sql(H.ORACLE).fetchall()}
    found = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in H.query(spark, data).collect()}
    assert found == expected


def test_large_hosts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 5)
    df = spark.createDataFrame([(k, f"http://h.com/{k}", f"<p>page {k}</p>") for k in range(40)], "page_id long, url string, html string")
    assert {r["text"] for r in H.extract(df).collect()} == {f"page {k}" for k in range(40)}


def test_runs_of_large_hosts_count_over_all_chunks(spark, monkeypatch):
    rng = random.Random(1)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(60)]
    said = [[] for _ in range(240)]
    for k, line in enumerate(lines):
        for page in rng.sample(range(200), 2 + k % 3):
            said[page].append(line)
    for page in range(200, 240):  # copies of other pages are no further pages
        said[page] = said[page - 150]
    own = [f"page {k if k < 200 else k - 150} itself" for k in range(240)]
    rows = [(k, f"http://h.com/{k}", f"<p>{own[k]}</p>" + "".join(f"<p>{x}</p>" for x in said[k])) for k in range(240)]
    rows += [(300 + k, f"http://small.com/{k}", f"<p>{lines[0]}</p>") for k in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(H.extract(df).collect())
    monkeypatch.setattr(H, "CHUNK", 5)
    assert sorted(H.extract(df).collect()) == whole
    by = {r["page_id"]: r["text"] for r in whole}
    for k, line in enumerate(lines):
        assert all((line in by[p]) == (k % 3 == 0) for p in range(240) if line in said[p])
